"""Operators over DataFrames; none collects its input."""
