"""Column functions: text, dates, scoring."""
