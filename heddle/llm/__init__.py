"""Training-data operators: deduplication, filtering, tokenising, packing, search and scoring at corpus scale."""
