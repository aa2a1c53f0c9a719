"""Operators for training-data pipelines: mixing, deduplication, filters, tokenisation and scoring of documents."""
