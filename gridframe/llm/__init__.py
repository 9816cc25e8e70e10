"""Operators for preparing training text and vectors. Nothing else in the library imports this subpackage."""
