"""Column builders; no Python row functions."""
