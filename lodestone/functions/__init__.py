"""Column functions, all of them native expressions."""
