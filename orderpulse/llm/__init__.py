"""Training-data operators (packing, language, dedup, quality, ...) and their queries."""
