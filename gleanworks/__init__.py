"""gleanworks: evidence retrieval and its evaluation as Spark DataFrame jobs."""
