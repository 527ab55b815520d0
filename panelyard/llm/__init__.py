"""Operators for training-data pipelines over documents, and the queries that serve them."""
