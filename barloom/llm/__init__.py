"""Operators for training-data pipelines over large text tables.

Nothing outside this package imports it.
"""
