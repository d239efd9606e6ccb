"""Append logs and their analytics on Spark DataFrames."""
