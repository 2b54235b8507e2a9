"""Operators and queries for training-data pipelines over the documents table."""
