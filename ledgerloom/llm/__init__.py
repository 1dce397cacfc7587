"""Operators for preparing training text, vectors and page lists."""
