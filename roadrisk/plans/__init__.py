"""Registered queries over the given tables, each with a reference SQL text where one exists."""
