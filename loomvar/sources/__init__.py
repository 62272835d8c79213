"""sources of the variant annotation engine."""
