"""Readers and writers of the text formats and their Parquet counterparts."""
