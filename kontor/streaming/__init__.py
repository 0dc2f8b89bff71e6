"""Incremental landing of document payloads with Structured Streaming."""
