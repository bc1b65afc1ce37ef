"""Column functions over DNA text and edge orientations."""
