"""Operators for building text corpora: tokens, media, deduplication, language, search, secrets, packing."""
