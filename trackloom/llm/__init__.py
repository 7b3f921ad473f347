"""Operators for training-data pipelines: cleaning, deduplication, filtering and encoding of document tables.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
