"""Column functions: URLs, dates, text and vectors."""
