"""Plans of bitloom."""
