"""Readers, and the audit domain derived from the given tables."""
