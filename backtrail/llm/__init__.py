"""Operators for large text corpora: near-duplicates, scans, scores, mixing, chat rendering and packing."""
