"""Corpus preparation, passage index and scoped search as Spark DataFrame jobs."""
