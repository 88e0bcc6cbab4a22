"""Column functions: text cleaning, dates, numbers."""
