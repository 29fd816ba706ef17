"""Readers, writers and the projections of relational tables to graphs."""
