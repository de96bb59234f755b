"""docloom: Spark jobs for chunked, embedded document corpora."""
