"""Operators for training-data text. Nothing outside this package imports it."""
