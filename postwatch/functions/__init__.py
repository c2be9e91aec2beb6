"""Column expressions: text folding, dates, salaries, places, labels, rounding."""
