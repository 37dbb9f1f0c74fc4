"""Structured Streaming twins of batch operators (file sources, availableNow triggers)."""
