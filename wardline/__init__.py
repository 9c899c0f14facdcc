"""Wardline: text-safety analytics on Spark.

Scanners and detectors are column expressions over a text column; the same definition serves batch jobs,
SQL and Structured Streaming.
"""

__version__ = "0.1.0"
