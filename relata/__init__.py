"""Relational and nested-data operators for Spark DataFrames."""
