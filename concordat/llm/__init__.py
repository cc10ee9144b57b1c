"""Operators of a training-data pipeline: packing, near duplicates, fingerprints, toxicity,
web archive derivatives, repeated substrings, tokenizing, exact search, token files, page text."""
