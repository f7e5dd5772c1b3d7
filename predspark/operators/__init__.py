"""Expressions over DataFrames: environments, programs, and how trees become Columns."""
