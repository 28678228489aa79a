"""Training-data operators: deduplication, labelling, mixing, sharding, packing and search."""
