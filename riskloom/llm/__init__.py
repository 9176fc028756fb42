"""Operators for large text corpora and vector tables, with their registered queries.

Nothing else in the library imports this subpackage.
"""
