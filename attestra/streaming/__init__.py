"""Structured Streaming: windows over event time, epochs, and ordered ingestion."""
