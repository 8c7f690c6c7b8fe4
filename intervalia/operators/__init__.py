"""Operators of the interval engine."""
