"""Operators for building training data from documents, vectors and web pages.

Each module holds one operator with its own interface; ``queries`` wraps them for the driver. Nothing else in the
library imports this package.
"""
