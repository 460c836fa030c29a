"""Structured Streaming jobs over job events."""
