"""Approximate line completion over text corpora, as Spark plans."""
