"""Scalar functions: text, keys and hashes, vectors, chunking, metadata filters."""
