"""Functions of bitloom."""
