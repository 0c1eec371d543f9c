"""DataFrame operators: retrieval, features, decisions, metrics, reports and models."""
