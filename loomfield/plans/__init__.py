"""Registered queries, their SQL and the end-to-end plan."""
