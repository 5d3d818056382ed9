"""sources of the link-graph engine."""
