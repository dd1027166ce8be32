"""Writers: CSV, JSON lines, N-Triples, curation tables, edit statements, metadata."""
