"""Reading and checking files."""
