"""Corpus operators for training data; nothing else in the package imports them."""
