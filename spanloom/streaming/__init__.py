"""Structured Streaming: ingest, live totals, windowed roll-ups and alert rules."""
