"""Spark-native document analytics and dataset curation."""
