"""plans of the statement engine."""
