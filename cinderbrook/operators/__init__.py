"""Generic verbs on DataFrames; column roles are parameters."""
