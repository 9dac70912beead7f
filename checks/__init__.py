"""Operator queries on the given tables, each with an equivalent SQL where one exists."""
