"""Spark-native ranking, retention and curation of short knowledge records."""

__version__ = "0.1.0"
