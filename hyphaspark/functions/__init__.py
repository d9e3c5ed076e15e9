"""Column builders: membership functions, scores, projections and grid keys."""
