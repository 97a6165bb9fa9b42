"""Operators for preparing training data: ten operators over tables of documents.

Nothing else in the package imports this subpackage.
"""
