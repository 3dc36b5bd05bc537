"""operators of citeloom."""
