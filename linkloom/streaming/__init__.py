"""streaming of the link-graph engine."""
