"""Panel time-series analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` that can be chained
with ``DataFrame.transform``.  See README.md for the layout of the package.
"""
