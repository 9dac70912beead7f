"""Structured Streaming versions of four daily rules."""
