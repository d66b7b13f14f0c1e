"""Spark jobs for knowledge corpora."""
