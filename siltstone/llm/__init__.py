"""Operators for preparing training data, one module each.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries for the entry module.
"""
