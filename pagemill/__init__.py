"""Spark-native analytics over captured web pages, documents and crawl events."""
