"""Scalar functions as Columns, and statistics."""
