"""Column functions: text, numbers, dates, names and payment handles."""
