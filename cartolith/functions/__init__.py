"""Column expressions: projections, tiles, geometry, values."""
