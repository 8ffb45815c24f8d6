"""memloom: graph-shaped, time-aware memory analytics as Spark jobs."""
