"""Column functions: exact money, text keys, quantiles."""
