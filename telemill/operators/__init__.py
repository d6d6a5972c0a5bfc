"""Operators: functions from DataFrames and plain arguments to lazy DataFrames."""
