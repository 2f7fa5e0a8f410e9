"""Column expressions and the three Arrow UDFs."""
