"""Event-time revision analytics on PySpark."""
