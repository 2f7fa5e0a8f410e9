"""Structured Streaming forms of response scoring and job status."""
