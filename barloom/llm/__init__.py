"""Operators of a training-data pipeline: each module is one operator, ``queries`` registers them.

Nothing else in the library imports this package.
"""
