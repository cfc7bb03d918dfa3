"""Structured Streaming over the facts as they arrive."""
