"""Corpus operators for training data: one module for each operator.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
