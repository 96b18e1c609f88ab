"""Spark-native retrieval, evidence and evaluation analytics over DataFrames."""
