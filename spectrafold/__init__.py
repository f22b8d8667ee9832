"""Graph-signal analytics on Spark."""
