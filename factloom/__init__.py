"""Analytics over engineering facts as Spark jobs."""
