"""Training-data operators: scoring, token counts, joins, dedup, rules, packing, extraction."""
