"""Read-signal, interval and callset analytics on Spark."""
