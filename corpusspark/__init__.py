"""Corpus and code-corpus analytics as Spark jobs: DataFrames in, DataFrames out."""
