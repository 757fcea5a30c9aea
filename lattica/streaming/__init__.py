"""Structured Streaming forms of the operators. These go beyond the reference, which has no event time."""
