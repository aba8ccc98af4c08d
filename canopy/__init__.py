"""Canopy: tree-document analytics on Spark DataFrames."""
