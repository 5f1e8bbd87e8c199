"""Spark-native engine for curated text, knowledge graphs and review queues."""
