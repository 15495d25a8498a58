"""Queries over the given tables, each beside the SQL that says what it must return."""
