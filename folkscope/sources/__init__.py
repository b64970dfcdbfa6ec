"""Reading and writing tables and records."""
