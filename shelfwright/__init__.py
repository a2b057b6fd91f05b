"""Shelfwright: a Spark-first engine for scanning, grouping and tidying large file corpora."""

__version__ = "0.1.0"
