"""Order-book analytics as Spark DataFrame jobs."""
