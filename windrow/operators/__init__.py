"""Operators: one function each, DataFrames in and out."""
