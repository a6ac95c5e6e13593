"""Writers: the graph as Parquet tables with their description, and as N-Triples."""
