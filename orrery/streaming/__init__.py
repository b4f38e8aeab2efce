"""Streams: latest states, rate limits, ingestion."""
