"""Queries over the driver's tables, each with its SQL."""

from foliospark.plans import contexts, documents, dynamic, extraction, files, names, outbox, policies, records, relational, results, retrieval, rulesets, streams, usage, versions
from foliospark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "contexts", "documents", "dynamic", "extraction", "files", "names", "outbox", "policies", "records", "relational", "results", "retrieval", "rulesets", "streams", "usage"]
