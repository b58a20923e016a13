"""Files, topics, published models and the test tables."""
