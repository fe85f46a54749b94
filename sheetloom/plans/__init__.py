"""Whole jobs composed of operators: inspect and match, convert, check."""
