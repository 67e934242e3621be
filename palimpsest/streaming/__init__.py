"""Structured Streaming change capture."""
