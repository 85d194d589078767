"""Operators of a training-data pipeline: cleaning, deduplication, tokens and packing at corpus scale."""
