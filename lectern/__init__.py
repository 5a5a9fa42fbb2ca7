"""Batch and streaming jobs for building, checking and serving a media and book catalogue on Spark."""

__version__ = "0.1.0"
