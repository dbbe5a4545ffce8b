"""Operators for large text corpora, and the queries registered for them."""
