"""Training-data operators: one module per operator, queries in ``queries``."""
