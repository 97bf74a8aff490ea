"""Whole jobs and operator configurations on the driver tables."""
