"""Audience analytics for viewer comments on Spark DataFrames."""
