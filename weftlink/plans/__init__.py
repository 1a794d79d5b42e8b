"""Shapes that several operators share, and the catalogue of queries."""
