"""corpusmill: corpus indexing, retrieval and evaluation as PySpark DataFrame jobs."""
