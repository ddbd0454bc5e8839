"""Operators for building training corpora (dedup, mixing, scans, models).

Nothing else in the library imports this subpackage.
"""
