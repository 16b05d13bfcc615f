"""drawwell: immutable sample caches and deterministic sampling, expressed as Spark DataFrames."""

__version__ = "0.1.0"
