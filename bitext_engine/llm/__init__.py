"""Operators for preparing training data at scale: duplicates, quality, licences, mixing, tokens and packing."""
