"""Training-data operators: one module per operator, plus ``queries`` that binds them to the tables."""
