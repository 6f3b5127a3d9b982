"""Event ordering and Structured Streaming forms of the scheduler."""
