"""Melody-corpus analytics on Spark DataFrames."""
