"""Operators of a training-data pipeline: cleaning, deduplication, packing and output of text corpora."""
