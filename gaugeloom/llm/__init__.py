"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage; its queries and SQL are in
``queries.py``.
"""
