"""Spark-native evaluation of speech transcripts, audio arrays and the records around them."""

__version__ = "0.1.0"
