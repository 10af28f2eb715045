"""What a query may read: models, policies and predicates."""
