"""operators of the registry engine."""
