"""Structured Streaming jobs over a folder feeds arrive in."""
