"""Column-level building blocks (no jobs are started here)."""
