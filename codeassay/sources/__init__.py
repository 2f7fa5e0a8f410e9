"""Readers and writers for task specs, run results and batch results."""
