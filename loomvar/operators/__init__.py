"""operators of the variant annotation engine."""
