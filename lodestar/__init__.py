"""Evaluation analytics for text-generation systems on Spark DataFrames."""
