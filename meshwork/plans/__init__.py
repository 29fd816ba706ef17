"""Fixed-point driving and the registered queries."""
