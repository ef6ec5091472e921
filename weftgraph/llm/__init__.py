"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames,
projects the columns it needs first (extra columns, also clashing ones, never
matter) and states its results for nulls, empty tables and repeated rows.
"""
