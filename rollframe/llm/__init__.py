"""Operators for large training-data pipelines, each built by one named method.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, selects the columns it needs by name (further input
columns, whatever their names, never reach its internals) and has a defined
result for nulls, empty texts, ties, repeated rows and empty tables, stated in
its docstring.
"""
