"""Landed files to typed rows, and typed rows to tables."""
