"""Operators for text corpora: deduplication, packing, scans, archives, tokens, quality."""
