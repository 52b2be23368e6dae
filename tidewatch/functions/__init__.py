"""Column builders: ordered windows, scalars, band tables."""
