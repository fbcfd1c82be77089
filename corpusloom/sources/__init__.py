"""Reads, writes and the logical schemas."""
