"""Document-evidence analytics on Spark: quotes, sources, event topologies and text gates as DataFrames."""
