"""Readers: delimited files under fixed schemas, checked Parquet, JSON, saved pages, a stream of new files."""
