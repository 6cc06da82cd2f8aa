"""Operator chains (ingest run, cluster run) and the query catalogue."""
