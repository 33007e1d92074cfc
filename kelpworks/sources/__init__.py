"""Readers: the parquet tables, the file-tree walker and the parsers of structured files."""
