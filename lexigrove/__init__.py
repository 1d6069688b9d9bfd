"""Lexigrove: an inverted-index search and data-processing engine built on PySpark DataFrames."""
