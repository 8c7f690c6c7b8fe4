"""Plans of the interval engine."""
