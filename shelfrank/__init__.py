"""shelfrank: product search, recommendation and review evidence as Spark jobs."""
