"""Structured Streaming: the weather archive, phases and observation capture."""
