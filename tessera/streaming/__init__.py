"""Operators: streaming."""
