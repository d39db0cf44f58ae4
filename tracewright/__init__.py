"""tracewright: performance-trace analytics on Spark DataFrames."""
