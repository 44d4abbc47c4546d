"""Structured Streaming wrappers and stateful operators."""
