"""Land-cover feature analytics on Spark: feature store, spatial statistics, overlay jobs and geometry functions."""

__version__ = "0.1.0"
