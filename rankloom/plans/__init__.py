"""Whole searches, evaluations and ingest jobs, composed from the operators."""
