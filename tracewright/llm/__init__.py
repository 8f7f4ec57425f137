"""Operators for large training corpora: filters, near-duplicates, mixing, packing, search."""
