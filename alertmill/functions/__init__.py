"""Column functions: they build expressions only, no jobs."""
