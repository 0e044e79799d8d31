"""tracewell: analytics over agent work records, declared as Spark DataFrames."""
