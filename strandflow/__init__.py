"""Spark-native analysis of legacy batch report programs, and corpus preparation on top of it."""

__version__ = "0.1.0"
