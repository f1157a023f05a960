"""Surface-profile analytics on Spark."""
