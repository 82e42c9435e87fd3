"""Millrace: data-science table work as Spark jobs (profiles, cleaning, reports, retrieval, scoring)."""

__version__ = "0.1.0"
