"""Queries by name, with the SQL that says the same."""

MODULES = ("search", "retrieval", "segment", "context", "extract", "operations", "lookups", "access", "indexes")
