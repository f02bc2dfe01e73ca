"""Vocabulary and byte-pair-encoding analytics over text corpora, as Spark DataFrame jobs."""
