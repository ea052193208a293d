"""Column expressions: text splitting, byte codes, metric formulas."""
