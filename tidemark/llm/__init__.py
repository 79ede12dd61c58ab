"""Training-data operators: language ID, deduplication, decontamination, mixing, sharding, tokens."""
