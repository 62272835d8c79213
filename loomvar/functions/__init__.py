"""functions of the variant annotation engine."""
