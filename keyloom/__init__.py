"""Keyed updates of immutable Parquet datasets, on Spark."""
