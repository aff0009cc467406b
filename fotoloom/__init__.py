"""Photo-archive analytics as DataFrame operators for Apache Spark."""

__version__ = "0.1.0"
