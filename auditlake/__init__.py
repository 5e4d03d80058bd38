"""Spend audit analytics on Spark."""
