"""Structured Streaming jobs. Each gives what its batch twin gives on the same rows."""
