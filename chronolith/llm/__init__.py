"""Training-data operators: dedup, extraction, scoring, packing, fingerprints, media and mixing."""
