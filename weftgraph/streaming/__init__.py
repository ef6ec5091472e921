"""Chunk streams as Structured Streaming: running checksums, status, fan-out."""
