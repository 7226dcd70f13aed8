"""operators of the statement engine."""
