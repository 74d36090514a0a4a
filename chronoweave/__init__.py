"""Temporal relational event tables on Spark: normalize, profile, generate, compare."""
