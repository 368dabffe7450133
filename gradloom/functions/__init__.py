"""Column functions over vectors, hashes and statistics."""
