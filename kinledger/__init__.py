"""Record linkage and ownership analytics on Spark."""
