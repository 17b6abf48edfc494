"""Stateful and incremental operators on Structured Streaming."""
