"""Operators for preparing language-model training data on Spark.

Nothing outside this package imports it.  Every operator is a function from DataFrames to a
DataFrame; `queries` holds the thin registered queries.
"""
