"""Structured Streaming forms of the session jobs."""
