"""Column functions and the small per-document helpers that run inside tasks."""
