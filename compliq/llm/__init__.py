"""Training-data operators: deduplication, filtering, mixing, sharding and counting over document tables."""
