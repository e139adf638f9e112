"""linelake: profiling, indexing and querying of line-delimited JSON with Spark."""
