"""Operators for large training-data pipelines.

Each module holds one operator with a general interface, and the thin query that applies it
to its whole table. Nothing else in quillgraph imports this package.
"""
