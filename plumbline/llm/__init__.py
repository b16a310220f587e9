"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage; it can be deleted.
"""
