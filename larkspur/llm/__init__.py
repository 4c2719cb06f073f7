"""Operators for large training-text collections, with their queries and SQL.

Nothing else in the library imports this subpackage.
"""
