"""Relational operators: corpus, search, association, term weights, exclusive clusters, views."""
