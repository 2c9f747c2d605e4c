"""Column functions: number formats, case, rounding and units."""
