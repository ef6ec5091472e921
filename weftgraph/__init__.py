"""Dataflow-graph analytics as DataFrame, SQL and Structured Streaming plans."""
