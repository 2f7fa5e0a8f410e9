"""Training-data operators: one module for each, with its thin query beside it."""
