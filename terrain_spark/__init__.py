"""Terrain-dataset analytics as lazy Spark plans."""
