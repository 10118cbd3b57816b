"""Readers and writers: corpora, the chunk store, page exports."""
