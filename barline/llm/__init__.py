"""Operators for the preparation of training text; nothing else in the library imports them."""
