"""Operators on DataFrames of any size."""
