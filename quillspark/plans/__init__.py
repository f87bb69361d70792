"""Query compilation and search plans."""
