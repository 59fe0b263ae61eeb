"""Spark-native code and text security analytics."""
