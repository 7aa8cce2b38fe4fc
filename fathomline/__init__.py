"""Spark-native spatial and statistical analytics."""
