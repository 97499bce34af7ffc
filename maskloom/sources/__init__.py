"""Readers of uploads and office files, and the layered store."""
