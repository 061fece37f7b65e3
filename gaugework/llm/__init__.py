"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; the repository works without it.
"""
