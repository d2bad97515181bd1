"""Column functions: text, dates, money, personal data, extracted fields."""
