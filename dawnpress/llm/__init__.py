"""Training-data operators: counting, mixing, searching, deduplicating, scoring, packing, redacting and labelling documents."""
