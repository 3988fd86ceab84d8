"""Readers of raw rows, and sinks for results and blobs."""
