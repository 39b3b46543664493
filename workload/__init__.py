"""Queries over the supplied test tables, with SQL twins for checking."""
