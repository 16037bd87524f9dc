"""Corpus preparation operators for training data: dedup, filtering, scoring, mixing, tokenising."""
