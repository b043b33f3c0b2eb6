"""Structured Streaming: continuous refresh of the index and of counts."""
