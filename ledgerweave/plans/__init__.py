"""Whole plans over statements."""
