"""Pure column expressions; nothing here starts a job or calls Python per row."""
