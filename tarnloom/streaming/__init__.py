"""streaming of the registry engine."""
