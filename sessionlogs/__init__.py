"""Session-log analytics on Spark: parse, correlate, grade and explain application logs."""

from sessionlogs.analysis import Analysis, analyse

__all__ = ["Analysis", "analyse"]
