"""Training-data operators: deduplication, sanitising, filtering, packing, token counts and token files."""
