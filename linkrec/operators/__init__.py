"""DataFrame operators: graph reshaping, candidates, labels, features, models."""
