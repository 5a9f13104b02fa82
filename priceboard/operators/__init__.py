"""Operators: each takes DataFrames and parameters and gives a DataFrame; none runs an action or reads a clock."""
