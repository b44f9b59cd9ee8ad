"""Structured evaluation on Spark: compare nested records, aggregate, report."""

__version__ = "0.1.0"
