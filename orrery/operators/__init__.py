"""Operators: functions from DataFrames to DataFrames, lazy throughout."""
