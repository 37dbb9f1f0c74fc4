"""Training-data operators: dedup, scans, language identification, extraction, sharding, packing."""
