"""Operators that prepare text and media for model training.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; :mod:`.queries` registers one thin query for each.
"""
