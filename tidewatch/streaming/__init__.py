"""Structured Streaming forms of the window operators."""
