"""Training-data operators: search, token files, deduplication, quality, mixing and encoding."""
