"""Planners: decide on the driver, return DataFrames."""
