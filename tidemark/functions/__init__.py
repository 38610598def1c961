"""Column expressions: texts and lists, dates, links."""
