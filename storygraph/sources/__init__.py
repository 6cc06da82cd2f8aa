"""Parquet tables that hold pages, articles, clusters, the URL ledger and counters."""
