"""Scalar functions of the code model."""
