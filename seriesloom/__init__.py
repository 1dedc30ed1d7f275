"""Panel time-series analytics on Spark DataFrames keyed by ``series_id``."""
