"""A fleet of repositories derived row by row from the benchmark tables."""
