"""Column expressions: text, numbers, dates, geometry, report extraction, pages."""
