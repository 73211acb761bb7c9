"""Column functions: text, units, dates and outcomes."""
