"""Operators for building training corpora.

Nothing else in the package imports this folder; `__spark_entry__.py` adds its
queries only where the folder exists.
"""
