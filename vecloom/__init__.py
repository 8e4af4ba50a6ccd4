"""vecloom: dense-vector search and table operators as Spark plans."""
