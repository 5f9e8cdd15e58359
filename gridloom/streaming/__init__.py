"""The same rules on files as they arrive."""
