"""Expressions over columns, and the functions that they call."""
