"""Column functions and ordered-data helpers."""
