"""Projections of given tables onto the graph model."""
