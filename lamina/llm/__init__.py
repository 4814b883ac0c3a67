"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
