"""streaming of citeloom."""
