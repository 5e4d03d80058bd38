"""Audit checks and reports, each over all documents at once."""
