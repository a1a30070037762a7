"""Queries over the test tables, with SQL that says the same."""
