"""Operators for preparing training data: deduplication, filtering, scanning, scoring and packing of documents."""
