"""rangeflow: range-partitioned, data-parallel analytics on Spark."""
