"""Spark-native information-gain trees over mixed-type tables."""
