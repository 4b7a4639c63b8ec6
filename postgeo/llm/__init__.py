"""Operators for the preparation of training text, and their queries."""
