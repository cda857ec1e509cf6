"""Partitioned read models and upserts."""
