"""Road-network building, routing and comparison as Spark DataFrame jobs."""
