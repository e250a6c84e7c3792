"""Structured Streaming form of the change-log fold."""
