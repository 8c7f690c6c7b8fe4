"""Streaming twins of the interval operators."""
