"""The expression language, predicates and feature policies, compiled to columns."""
