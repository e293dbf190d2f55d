"""Scalar functions over key and value columns."""
