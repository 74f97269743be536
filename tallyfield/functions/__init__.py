"""Scalar column functions: every one returns a native Column expression."""
