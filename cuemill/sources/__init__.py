"""Reading files into tables."""
