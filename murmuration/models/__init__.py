"""Example simulations composed from the operators."""
