"""Queries over the tables, and the SQL each must agree with."""
