"""Readers: every record format becomes DataFrames of the logical tables."""
