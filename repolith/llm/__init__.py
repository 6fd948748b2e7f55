"""Operators for large text corpora: near duplicates, splitting, secrets, syntax, provenance, tokens, leakage, sentences."""
