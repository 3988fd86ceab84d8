"""Operators over tables of leads, extractions, events, results and reviews."""
