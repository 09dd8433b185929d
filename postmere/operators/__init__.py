"""Relational operators over records, messages and enrichments."""
