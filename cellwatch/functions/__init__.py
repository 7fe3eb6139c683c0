"""Column functions: parsing, cell arrays and interpolation, all built-in expressions."""
