"""Operators of a training-data pipeline over text, conversation, vector and page tables.

Nothing else in the library imports this subpackage.
"""
