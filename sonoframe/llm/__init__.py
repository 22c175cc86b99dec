"""Operators for training data built from transcripts and documents. Nothing outside this package imports it."""
