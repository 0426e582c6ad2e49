"""Readers and writers: Parquet, JSON lines, tables and views."""
