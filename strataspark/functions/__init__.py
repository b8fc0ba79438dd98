"""Column builders: scalar functions as expressions."""
