"""Column functions: text, hashing, numbers and dates."""
