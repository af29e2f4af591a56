"""Column expressions: calendar arithmetic, weather acceptance, text and geometry."""
