"""Relational, graph and resolution operators."""
