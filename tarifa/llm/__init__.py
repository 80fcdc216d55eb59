"""Training-data operators: token counts, scoring, filters, near-duplicates, extraction, formatting and packing."""
