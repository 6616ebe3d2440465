"""Incremental ingestion and monitoring."""
