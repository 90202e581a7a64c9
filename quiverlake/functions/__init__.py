"""Column builders: vectors, sparse vectors, text and hashes."""
