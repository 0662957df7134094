"""Training-data operators: sampling, deduplication, scoring, sharding and layout of text corpora."""
