"""Column expressions: no operator here starts a job or moves a row."""
