"""Operators for preparing training data: deduplication, scans, scoring, tokens, packing.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` binds them to the driver's tables.
"""
