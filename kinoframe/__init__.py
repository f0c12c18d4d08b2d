"""Kinoframe: Spark-native analytics over timestamped media relations."""
