"""Column functions: text, hashing, time, geometry, classification."""
