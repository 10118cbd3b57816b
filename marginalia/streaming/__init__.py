"""Structured Streaming: change events to ingest runs, questions to hits, partial answers to deltas."""
