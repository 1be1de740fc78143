"""Training-data operators: fingerprints, quality rules, tokenising, dedup, mixing, scans and scoring."""
