"""Training-data operators: token counts, decontamination, duplicates, packing, archives, quality, sharding, toxicity, page text."""
