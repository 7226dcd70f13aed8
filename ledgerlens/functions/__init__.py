"""functions of the statement engine."""
