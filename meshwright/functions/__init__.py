"""Column expressions (strings, geometry, scores, hashes)."""
