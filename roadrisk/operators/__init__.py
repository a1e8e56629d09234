"""Batch operators: functions from DataFrames to DataFrames, without collect or Python workers."""
