"""Compressed streams as tables."""
