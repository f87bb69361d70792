"""Scalar functions: analyzers and the stemmer."""
