"""Training-data operators: deduplication, quality, language, privacy, mixing and chat."""
