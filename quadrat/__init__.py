"""Box analytics on Spark: DataFrame operators over object-box records."""

__version__ = "0.1.0"
