"""Column helpers: references, dates, text and codes."""
