"""Structured Streaming queries over operational events."""
