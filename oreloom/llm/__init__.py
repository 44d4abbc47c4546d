"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries`` derives the contract's digest columns from them.
"""
