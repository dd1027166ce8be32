"""Readers: triples, result CSV, query-result JSON, curation tables, star schema."""
