"""Index construction, ranking, encoding and validation operators."""
