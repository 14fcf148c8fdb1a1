"""Sievework: Spark-native content scanning and risk scoring."""
