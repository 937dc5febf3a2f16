"""Search, scoring, mutation and evaluation over an index."""
