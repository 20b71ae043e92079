"""Column expressions: geodesy, rotations, symmetric matrices, names and times."""
