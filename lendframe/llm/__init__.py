"""Operators for text corpora: deduplication, filtering, scanning, tokenising, mixing, search and archives."""
