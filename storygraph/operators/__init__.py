"""DataFrame operators: extraction, selection, dedup, vector joins, clustering, upkeep."""
