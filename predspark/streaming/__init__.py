"""Decisions over documents that arrive as a stream of events."""
