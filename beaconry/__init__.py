"""Request observability and zone analytics as Spark DataFrame jobs."""
