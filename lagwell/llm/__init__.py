"""Operators for preparing text corpora: tokens, privacy, duplicates, pages, shards and sequences."""
