"""Spark-native processing of time-coded meeting transcripts."""

__version__ = "0.1.0"
