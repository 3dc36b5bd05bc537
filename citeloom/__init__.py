"""citeloom: cited retrieval and corpus processing as Spark jobs."""
