"""Date x instrument panel analytics as Spark DataFrame operations."""
