"""Operators for training-data pipelines over whole document tables.

Nothing else in the library imports this subpackage.
"""
