"""Operators for training-data pipelines: one module per operator, ``queries`` registers them.

Nothing else in the library imports this package.
"""
