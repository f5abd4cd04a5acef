"""Column functions: text, dates and scores."""
