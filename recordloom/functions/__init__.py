"""Column expressions: text, codes, dates, hashing, geometry, vectors, variant access."""
