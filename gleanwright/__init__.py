"""Spark-native evidence retrieval, corpus curation and evaluation."""
