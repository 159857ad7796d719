"""Operators: operators."""
