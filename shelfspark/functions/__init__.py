"""Column expressions used by the operators and jobs."""
