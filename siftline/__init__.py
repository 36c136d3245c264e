"""Siftline: multilingual search analytics on Spark DataFrames."""
