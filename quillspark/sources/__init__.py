"""Reading corpora, indexes and settings, and writing indexes."""
