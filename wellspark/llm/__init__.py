"""Training-data operators: each takes DataFrames and returns DataFrames; ``queries`` applies them to the given tables."""
