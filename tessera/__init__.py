"""Spark-native sharded analytics, model synchronisation and corpus operators."""

__version__ = "0.1.0"
