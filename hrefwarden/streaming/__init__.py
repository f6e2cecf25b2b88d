"""The audit on a stream of documents."""
