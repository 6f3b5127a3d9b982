"""Operators over agent tables: populations, spaces, rasters, networks, logs."""
