"""Operators for preparing training data: deduplication, extraction, scoring, packing and formatting.

Nothing outside this subpackage imports it. The registered queries are in :mod:`findspan.llm.queries`.
"""
