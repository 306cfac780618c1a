"""Operators: each takes tables and gives a table."""
