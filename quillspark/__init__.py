"""A Spark-native engine for full-text indexing and ranked search."""
