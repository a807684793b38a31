"""Composed analyses and the query catalog."""
