"""Spark-native engine that turns heterogeneous tabular uploads into reviewed records."""
