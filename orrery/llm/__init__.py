"""Training-data operators: formatting, deduplication, mixing, tokenising, scoring and search."""
