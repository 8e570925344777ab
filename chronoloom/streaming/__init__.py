"""Event-driven behaviour on Structured Streaming."""
