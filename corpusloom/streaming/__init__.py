"""Structured Streaming forms of the operational queries."""
