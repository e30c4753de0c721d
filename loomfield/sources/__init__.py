"""Readers of raw files and writers of results."""
