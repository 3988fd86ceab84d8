"""Verification of payment records against the fields read from their documents, and analytics over the outcome."""
