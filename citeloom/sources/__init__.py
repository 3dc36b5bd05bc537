"""sources of citeloom."""
