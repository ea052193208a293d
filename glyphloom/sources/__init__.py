"""Readers and writers: corpora, models, encoded tables, run metrics."""
