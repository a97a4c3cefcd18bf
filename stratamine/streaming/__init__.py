"""Streaming operators on Structured Streaming."""
