"""Job-posting graph analytics as Spark DataFrame jobs."""
