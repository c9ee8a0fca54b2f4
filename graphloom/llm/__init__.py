"""Training-data operators: dedup, scoring, extraction, tokenising and search over text tables."""
