"""Operators on DataFrames: rules, order, distinct values, cleaning, joins, splits, edits."""
