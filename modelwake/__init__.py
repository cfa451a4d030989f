"""Model monitoring and point-in-time feature engineering on Spark DataFrames."""

__version__ = "0.1.0"
