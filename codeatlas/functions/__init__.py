"""Column functions over text, labels and codes."""
