"""Operators over the logical tables; each takes and gives DataFrames."""
