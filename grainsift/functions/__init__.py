"""Column expressions: type selection, text measures and similarities."""
