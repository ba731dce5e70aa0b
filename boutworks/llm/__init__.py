"""Operators that prepare training text."""
