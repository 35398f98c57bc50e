"""Structured Streaming jobs and replay-safe sinks."""
