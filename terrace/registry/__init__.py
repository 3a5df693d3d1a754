"""Named queries over the benchmark tables, with their check SQL."""
