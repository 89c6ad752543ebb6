"""Registered queries: each applies an operator to the given tables, with its SQL."""
