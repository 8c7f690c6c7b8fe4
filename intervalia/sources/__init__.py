"""Sources of the interval engine."""
