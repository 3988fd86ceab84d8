"""Incremental ingestion, windows over events and identity verdicts that last across batches."""
