"""Column functions: borders, neighbourhoods, tiling, counter-based draws."""
