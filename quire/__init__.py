"""Spark-native analytics over large collections of textbook-style documents."""
