"""Training-data operators: fingerprints, scoring, tokenising, filtering and deduplication of documents."""
