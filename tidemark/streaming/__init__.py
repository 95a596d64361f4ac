"""Structured Streaming jobs over arriving scripts and attempts."""
