"""Reading and writing panels and tables."""
