"""Column functions: text, paths, predicates."""
