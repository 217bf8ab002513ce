"""Trip and demand analytics on Spark: canonical trips, quality rules, marts, models, measures."""

__version__ = "0.1.0"
