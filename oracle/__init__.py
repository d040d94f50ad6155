"""Comparison queries: the same results as the Spark jobs, written independently as DuckDB SQL."""
