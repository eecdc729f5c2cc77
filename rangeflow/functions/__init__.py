"""Column functions: integer generators, rounding, array algebra."""
