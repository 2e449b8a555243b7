"""Checks and small helpers on DataFrames."""
