"""Passage retrieval and ranking as Spark jobs.

Every operator takes DataFrames and gives a DataFrame.  See README.md for a
map of the package.
"""
