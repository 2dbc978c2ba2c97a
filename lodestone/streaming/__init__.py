"""Structured Streaming: keeping an index current as files change."""
