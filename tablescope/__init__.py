"""Tabular profiling, cleaning, pattern finding and model comparison on Spark."""
