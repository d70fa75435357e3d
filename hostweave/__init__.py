"""Spark-native network-traffic graph analytics."""
