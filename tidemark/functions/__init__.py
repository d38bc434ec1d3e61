"""Column expressions: parsing, scoring and banding of single values."""
