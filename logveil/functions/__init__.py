"""Column functions: text, hashing, checks and record structure."""
