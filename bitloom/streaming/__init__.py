"""Streaming of bitloom."""
