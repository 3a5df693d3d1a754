"""Column-level building blocks: text, numbers, lexicons and arrays."""
