"""Structured Streaming form of the capture-gap analysis."""
