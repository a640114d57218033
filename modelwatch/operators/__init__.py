"""DataFrame → DataFrame operators. Column names and grouping keys are parameters."""
