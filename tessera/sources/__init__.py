"""Operators: sources."""
