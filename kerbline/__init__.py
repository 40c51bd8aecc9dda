"""Road-survey analytics as Spark DataFrame jobs."""
