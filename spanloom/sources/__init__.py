"""Readers: JSON payloads and day-partitioned signal tables."""
