"""Datasets, readers and writers."""
