"""Reading and writing labeled matrices."""
