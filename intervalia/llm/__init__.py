"""Training-data operators: selection, deduplication, scanning, encoding."""
