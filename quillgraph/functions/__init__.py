"""Scalar text functions as column expressions."""
