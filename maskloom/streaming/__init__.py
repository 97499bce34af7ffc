"""Structured Streaming form of the masking plan."""
