"""plans of the variant annotation engine."""
