"""Spark-native analytics over smart-contract deployments."""
