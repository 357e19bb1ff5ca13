"""Cubes over known schemas."""
