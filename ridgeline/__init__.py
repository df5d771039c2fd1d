"""Ridgeline: a mobility-analytics engine expressed with Spark DataFrames and SQL."""
