"""Scalar functions over keys, ids and validation rules."""
