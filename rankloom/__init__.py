"""rankloom: ranking the nodes of large weighted graphs on Spark."""
