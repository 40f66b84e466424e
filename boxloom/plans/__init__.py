"""Queries of the vector engine with their SQL."""
