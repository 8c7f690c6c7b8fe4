"""Functions for SQL."""
