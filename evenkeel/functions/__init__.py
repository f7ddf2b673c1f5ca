"""Column expressions: hashing, key encoding, integer and skew arithmetic."""
