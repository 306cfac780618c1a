"""Intake as a stream."""
