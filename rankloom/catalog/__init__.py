"""Registered queries over the driver tables, and their check SQL."""
