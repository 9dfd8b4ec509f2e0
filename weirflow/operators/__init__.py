"""Operators: functions from DataFrame to DataFrame, or to several by name."""
