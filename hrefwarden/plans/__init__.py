"""Whole audits, and the corpora derived from the test tables."""
