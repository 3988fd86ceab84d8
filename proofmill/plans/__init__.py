"""Whole plans: lead processing, re-verification, approvals, and the analytic queries."""
