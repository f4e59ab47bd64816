"""Column functions and statistics over long tables."""
