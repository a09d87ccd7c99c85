"""Operators: functions from DataFrames to a lazy DataFrame, over all instruments at once."""
