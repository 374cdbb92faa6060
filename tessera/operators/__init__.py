"""Operators over DataFrames: checks, version algebra, joins."""
