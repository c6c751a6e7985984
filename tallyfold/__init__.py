"""Labelled-table preparation, fingerprinting, boosted-tree learning and exact evaluation on Spark."""

__version__ = "0.1.0"
