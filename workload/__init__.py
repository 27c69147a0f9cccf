"""Queries over the supplied tables, each with its SQL check where one exists."""
