"""Graph operators: each takes a Graph and returns a DataFrame."""
