"""quarry: governed knowledge retrieval and corpus processing as plain Spark plans."""
