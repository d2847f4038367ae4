"""Incremental operators: tables with versions, upserts, dead letters, streams."""
