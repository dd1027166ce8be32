"""Whole searches and curation runs composed of the operators."""
