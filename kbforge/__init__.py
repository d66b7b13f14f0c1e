"""Spark jobs that build, search, reconcile and measure support-knowledge corpora."""
