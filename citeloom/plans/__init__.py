"""plans of citeloom."""
