"""Operators on nodes, decisions, scripts, documents, registries and plain data."""
