"""Multi-pattern search over text and binary tables, planned as Spark DataFrames."""

__version__ = "0.1.0"
