"""Document retrieval, curation and evaluation analytics on PySpark."""
