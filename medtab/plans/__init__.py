"""Registered queries and the report view they read."""
