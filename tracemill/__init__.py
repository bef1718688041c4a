"""Spark-native engine for assistant session records and corpus preparation."""
