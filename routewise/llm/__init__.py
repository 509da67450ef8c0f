"""Operators for building training corpora: filtering, deduplication,
scoring, tokenising, sharding and search over tables of documents."""
