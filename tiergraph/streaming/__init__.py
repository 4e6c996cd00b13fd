"""Streaming feed of content changes."""
