"""Plainsight: screening of interface texts and auditing of the data behind it, on Spark."""

__version__ = "0.1.0"
