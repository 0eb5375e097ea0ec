"""Scalar functions: normalisers, keys, identifiers."""
