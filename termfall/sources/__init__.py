"""Readers of corpora and stored indexes."""
