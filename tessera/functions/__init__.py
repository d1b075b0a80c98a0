"""Column functions: text, extraction, JSON, dates, losses."""
