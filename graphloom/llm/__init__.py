"""Training-data operators: dedup, filters, scans, mixing, sharding, chat formatting."""
