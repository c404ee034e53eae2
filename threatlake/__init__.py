"""Security analytics on Spark DataFrames: cleaning, star schema, insider scoring, detection reports."""

__version__ = "0.1.0"
