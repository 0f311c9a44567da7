"""Gradeloom: teaching-data operators written as Spark DataFrame transformations.

Every operator takes DataFrames and plain parameters and returns a lazy DataFrame.
Scope (course, assignment, chain, file) is always a grouping key, never a loop.
"""
