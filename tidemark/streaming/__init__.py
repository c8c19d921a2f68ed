"""Structured Streaming versions of the weekly measurements (extensions)."""
