"""Corpus curation on Spark: sources, text functions, governance operators, plans, sinks and streaming."""
