"""Column expressions: unsigned arithmetic, hashes, bucketers."""
