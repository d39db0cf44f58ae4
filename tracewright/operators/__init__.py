"""Analyses of a trace: functions from DataFrames and parameters to DataFrames."""
