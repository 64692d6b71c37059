"""Column expressions over text, time and numbers."""
