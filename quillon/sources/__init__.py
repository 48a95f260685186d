"""Models, databases and the versioned table store."""
