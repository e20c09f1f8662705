"""Catalogue construction, requirement matching and compliance analysis on Spark DataFrames."""
