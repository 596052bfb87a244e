"""Document-corpus preparation, repeated-text detection and answer evaluation as Spark jobs."""
