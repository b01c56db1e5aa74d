"""Training-data operators: scans, extraction, formatting, mixing, filters, deduplication and packing."""
