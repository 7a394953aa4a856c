"""Operators that prepare training data from raw text. Nothing else in the library imports this package."""
