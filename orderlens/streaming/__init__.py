"""Structured Streaming: ingest, running figures and the refresh."""
