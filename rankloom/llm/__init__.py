"""Operators for building training text: one module each, queries in ``queries``."""
