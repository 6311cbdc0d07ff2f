"""Training-data operators: quality, deduplication, decontamination, extraction, packing, token files."""
