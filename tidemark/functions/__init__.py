"""Column functions: no shuffles, no state, the same on tables and on streams."""
