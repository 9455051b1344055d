"""Readers and writers: typed text tables, Parquet, C5 files, rule lists, clusterings and result reports."""
