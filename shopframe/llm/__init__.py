"""Training-data operators: packing, near-duplicate and substring removal, archives, tokenising, text rules."""
