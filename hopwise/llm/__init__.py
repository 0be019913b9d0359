"""Training-data operators: extraction, deduplication, quality, tokenising, packing and sharding."""
