"""Column functions: typed comparisons, checked arithmetic and decisions."""
