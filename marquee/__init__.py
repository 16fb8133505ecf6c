"""Marquee: a Spark-native engine for media planning, its warehouse, and corpus preparation."""
