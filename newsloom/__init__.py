"""newsloom: content monitoring and evidence statistics as Spark jobs."""
