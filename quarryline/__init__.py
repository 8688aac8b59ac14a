"""Analytics over software-repository history, written as Spark jobs."""
