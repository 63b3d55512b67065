"""A Spark-native engine for full-text search, search analytics and text corpora."""
