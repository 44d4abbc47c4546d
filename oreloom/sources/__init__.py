"""Readers: source trees, registries, skill folders."""
