"""Selections: a logical plan of a table and a predicate."""
