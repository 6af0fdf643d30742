"""Queries over the six signals. Every function takes and returns DataFrames."""
