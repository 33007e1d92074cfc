"""Operators that prepare text, code and vectors for training; nothing outside this package imports it."""
