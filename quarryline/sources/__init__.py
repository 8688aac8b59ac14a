"""Readers and writers: commit logs, pull requests, notes, documents, the index, caches, exports."""
