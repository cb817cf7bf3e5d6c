"""Operators on DataFrames: exploring, facets, selection, aggregation, merging, history, planning, audits."""
