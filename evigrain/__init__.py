"""evigrain: reproducible evidence retrieval and its measurement on Spark DataFrames."""

__version__ = "0.1.0"
