"""Spark jobs over linked knowledge bases: pages, journals, tasks, code indexes and their embeddings."""
