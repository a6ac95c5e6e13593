"""Readers: tables (CSV, JSON, Parquet), RDF, and the documents that describe shapes."""
