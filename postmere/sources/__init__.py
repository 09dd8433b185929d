"""Readers: parquet tables and the record, message and document schemas."""
