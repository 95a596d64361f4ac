"""Operators for cleaning and measuring training text. Nothing else in the library imports them."""
