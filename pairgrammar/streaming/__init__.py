"""Structured Streaming forms of the resumable jobs."""
