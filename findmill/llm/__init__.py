"""Operators of a training-data pipeline: packing, deduplication, extraction, scans and scores."""
