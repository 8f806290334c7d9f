"""Training-data operators: near-dedup, quality, tokens, packing, decontamination, PII."""
