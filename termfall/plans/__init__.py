"""The inverted index as relations."""
