"""Complete jobs made of the operators."""
