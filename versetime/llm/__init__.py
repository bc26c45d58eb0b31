"""Training-data operators: deduplication, decontamination, mixing, packing and scoring."""
