"""Key-state analytics on Spark: folds, placement, digests, recovery and change processing."""
