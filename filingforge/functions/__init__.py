"""Column expressions: dates, amounts, labels."""
