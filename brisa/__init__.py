"""Address standardization and corpus preparation on Spark."""
