"""Spark-native analytics of vector fields that are known at a few moving places."""
