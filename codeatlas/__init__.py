"""Code lists and training data as Spark DataFrame jobs."""
