"""Training-data operators: tokenising, scoring, deduplication and packing of text corpora."""
