"""Schemas, readers, writers, adapters and synthetic data."""
