"""Transaction-graph analytics as lazy Spark plans."""
