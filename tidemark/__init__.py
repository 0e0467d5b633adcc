"""Tidemark: Spark-native analytics over trade and quote event streams."""
