"""Whole flows: the mining plan, its sinks and command line."""
