"""Scalar functions and models."""
