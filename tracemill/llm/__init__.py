"""Training-data operators: tokenising, language ID, archives, deduplication, media, search, packing and filters."""
