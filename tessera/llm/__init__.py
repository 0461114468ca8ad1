"""Training-data operators: dedup, joins, tokens, packing, quality and search."""
