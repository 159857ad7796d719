"""Operators: functions."""
