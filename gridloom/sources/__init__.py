"""Reading and writing delimited files."""
