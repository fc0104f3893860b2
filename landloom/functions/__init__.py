"""Scalar expressions of the library."""
