"""Operators on signals: DataFrames with keys (ch by default), sample index n and value re."""
