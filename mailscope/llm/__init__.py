"""Operators for building training data from a corpus of documents. Nothing outside this folder imports them."""
