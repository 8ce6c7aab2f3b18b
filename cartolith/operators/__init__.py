"""Operators over feature DataFrames: selection, profiles, restructuring, joins with points."""
