"""Training-data operators: extraction, dedup, mixing, scans, scoring and token output."""
