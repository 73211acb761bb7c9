"""Relational operators over facts, events, text and logs."""
