"""Relational jobs: DataFrames in, DataFrames out."""
