"""Operators for training data: one module each, queries in ``catalog``."""
