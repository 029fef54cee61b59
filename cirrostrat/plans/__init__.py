"""Queries composed from the operators, on the driver's tables."""
