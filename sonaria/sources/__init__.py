"""Readers and writers for clips, registries, corpora, voices and frames."""
