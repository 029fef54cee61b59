"""Operators on DataFrames of grid points, members and observations."""
