"""Training-data operators: scoring, decontamination, near-duplicates, packing, archives, rules."""
