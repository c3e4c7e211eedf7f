"""Incremental intake and job state with Structured Streaming."""
