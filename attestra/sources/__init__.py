"""Readers and writers: databases, JSON, logs, files, and the mapping of their rows to documents."""
