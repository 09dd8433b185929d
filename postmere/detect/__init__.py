"""Span detection and redaction."""
