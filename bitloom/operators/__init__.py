"""Operators of bitloom."""
