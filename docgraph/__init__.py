"""Batch and streaming jobs that turn structured documents into a queryable document graph."""
