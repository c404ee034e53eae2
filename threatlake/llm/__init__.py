"""Operators for training-data pipelines: filters, near-duplicates, tokenizers, search, mixing, language models."""
