"""Spark-native spatial gene-regulation analytics."""
