"""Structured Streaming jobs that keep state tables up to date."""
