"""Operators for large text corpora: packing, deduplication, extraction, search, scans and output."""
