"""Spark-native retrieval, evidence and evaluation analytics over tables of documents."""
