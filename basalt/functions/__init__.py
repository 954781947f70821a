"""Column functions with the host database's meaning."""
