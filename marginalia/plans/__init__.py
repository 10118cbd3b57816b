"""Whole runs: ingest a corpus, answer questions, and the catalog of checked queries."""
