"""Scalar functions: Columns to Columns."""
