"""Readers that turn stored documents into tables, and the writers of results."""
