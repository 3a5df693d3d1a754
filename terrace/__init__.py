"""Crowd-mood analytics on Spark: DataFrame in, DataFrame out, keyed by fixture."""
