"""Structured Streaming forms of the few operators that make sense on live data."""
