"""Corpora as DataFrames: files, chunks, symbols, edges; writers."""
