"""Data preparation, leakage control and promotion gating for labelled tables, on Spark DataFrames."""
