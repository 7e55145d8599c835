"""Set-membership, sketching and skew-safe aggregation on Spark DataFrames."""

__version__ = "0.1.0"
