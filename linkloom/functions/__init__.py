"""functions of the link-graph engine."""
