"""Paired-comparison rating analytics and corpus preparation on Apache Spark."""

__version__ = "0.1.0"
