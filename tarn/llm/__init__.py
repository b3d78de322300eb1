"""Operators for preparing training text; each module is one operator and nothing outside imports them."""
