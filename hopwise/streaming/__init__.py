"""Incremental merging of per-genome distance summaries."""
