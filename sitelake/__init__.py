"""Spark-native analytics for crawled web sites."""
