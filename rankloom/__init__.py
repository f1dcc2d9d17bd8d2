"""Spark-native analysis of ranked result lists."""

__all__ = ["session", "schemas"]
__version__ = "0.1.0"
