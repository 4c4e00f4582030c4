"""Column functions: pure expressions over a file's path, text or URL."""
