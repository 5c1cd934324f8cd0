"""Spark-native ingestion and retrieval over tables of articles, chunks, questions and turns."""
