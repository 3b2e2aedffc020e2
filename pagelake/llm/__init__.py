"""Corpus operators for training-data pipelines (nothing else in pagelake imports this)."""
