"""Corpus indexing and search on Spark: files in, derived tables and answers out."""
