"""operators of the link-graph engine."""
