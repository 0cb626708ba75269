"""Curation of large asset collections on Spark: filters, duplicates, representatives, exports, incremental features."""

__version__ = "0.2.0"
