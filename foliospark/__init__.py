"""foliospark: document analytics and corpus preparation on PySpark."""
