"""Relational, statistical, neighbour, graph and clustering operators."""
