"""Streaming forms of the kernels."""
