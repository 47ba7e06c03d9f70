"""Column functions: text clean-up, fingerprints, similarity measures."""
