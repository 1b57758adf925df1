"""docloom: documentation analytics on Spark."""
