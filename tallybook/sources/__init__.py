"""Reading raw files, checking them, and publishing built tables."""
