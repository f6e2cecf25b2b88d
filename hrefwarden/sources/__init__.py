"""Readers and writers: document tables, file trees, the two cache tables."""
