"""Training-data operators: scoring, mixing, filtering, deduplication, formatting and packing."""
