"""Fleet hardware-readiness analytics on Spark."""
