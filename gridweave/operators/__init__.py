"""Operators: functions from DataFrames to a DataFrame, declared with built-in functions, joins and windows."""
