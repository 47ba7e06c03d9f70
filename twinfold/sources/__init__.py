"""Reading, validating, updating and storing the article and cluster tables."""
