"""Operators bound to concrete tables, each next to its equivalent SQL."""
