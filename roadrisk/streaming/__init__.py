"""Structured Streaming jobs: event scoring, histories, sinks and windows."""
