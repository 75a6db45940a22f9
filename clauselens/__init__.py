"""Spark-native analytics over collections of policy-style documents."""
