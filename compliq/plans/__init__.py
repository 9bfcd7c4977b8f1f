"""Specifications, their validation, and the two ways in which they run: compiled to columns, or in detail on one document."""
