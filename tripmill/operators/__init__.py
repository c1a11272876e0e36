"""Filters and metrics: DataFrame in, lazy DataFrame out."""
