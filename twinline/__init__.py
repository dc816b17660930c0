"""twinline: finding, grouping and measuring duplicate short texts with PySpark."""

__version__ = "0.1.0"
