"""Jobs, queue items and ingestion as state over events, in batches and in Structured Streaming."""
