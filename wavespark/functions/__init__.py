"""Column functions on paths and 4-state values."""
