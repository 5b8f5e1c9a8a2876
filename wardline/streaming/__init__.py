"""Structured Streaming jobs; windows and aggregates also run on batch tables."""
