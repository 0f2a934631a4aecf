"""Column expressions: scoring, text and number helpers that stay inside generated code."""
