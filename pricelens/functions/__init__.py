"""Column expressions; no function here starts a job or sees a DataFrame."""
