"""Operators: functions from DataFrames to DataFrames, each keyed by a list of columns."""
