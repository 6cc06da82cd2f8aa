"""Incremental story clustering over news pages, written as Spark table and stream jobs."""
