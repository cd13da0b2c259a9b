"""Operators for preparing training text: deduplication, extraction, safety and mixing.

Nothing outside this subpackage imports it.
"""
