"""functions of citeloom."""
