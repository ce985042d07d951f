"""Training-data operators: scans, filters, dedup, packing and formatting of text tables."""
